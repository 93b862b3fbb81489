"""Mixing sources to target weights over fixed-length token blocks, with DataFrame functions only.

Every source is read as one line of words, its documents laid end to end and packed into blocks of ``block_words`` words
(the last one shorter). A source's target in words becomes slots: whole passes over its blocks, then as many slots of one
more pass as the rest needs, the very last one cut so that the source meets its target to the word. Slot k of a pass takes
block perm(k), a pseudorandom permutation of the source's block numbers seeded by source and pass; so no pass takes a
block twice, and with targets of at most twice the size nothing is taken more than twice.

Output shards get multinomial source counts: each of a shard's positions draws a source, by a hash of shard and position, with odds as the slots of the
targets. A source's counts are summed up over the shards before, which says which of its slots a shard takes. What was drawn beyond a source's slots is left
out, and what was never drawn goes to the last shard, so that the targets are met; the sums of draws differ from the slots by about the square root
of these. Words are found by joining slots and documents on (source, block).

The permutations are swap-or-not networks: each round pairs x with key - x (mod n) and a hash bit of the pair decides
whether they swap. They work for every n, need no table, and the same rounds backwards invert them.

Running sums are taken in levels (sums per chunk, then within a chunk), so that one source may hold any share of the
rows and no window grows with the table. Only the table of sources, one row each, goes through a single window.

The tables of running sums, of sources and of slots are written before what joins them. The driver makes and reports a plan anew after each of its
shuffles; one plan for all took most of its memory, by the square of its shuffles.

Defined cases: null or wordless text has size 0 and takes 0; very long texts span many blocks and are cut once per row of the mix; a null source is a source of its own, last in order; rows that repeat are
documents of their own, next to each other; ties of doc_id and size are ordered by a hash of the text, and what ties there too is the same row; null ``doc_id`` rows take part and are dealt
by their texts; an empty table gives an empty result; further columns are kept by :func:`mix` and ignored by :func:`taken`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialize, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 512
#: Output positions of a shard.
SHARD_SLOTS = 1024
#: Documents whose positions one task sums up at a time, on average, and how many parts a level of running sums puts together.
CHUNK = 1024
#: Levels of running sums above the lowest: a window then sees one row in CHUNK^2 of what it sums.
LEVELS = 2
ROUNDS = 24


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, s, size, tie, uid): s orders as the sources do, null last; tie is a hash of the text; uid numbers the rows, or is what ``row_col`` holds."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source)).alias("s"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("uid"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """(s, source_size, target, ...) from (s, source_size).

    Targets go by weight up to ``most`` times the size. Sorted by size per weight, the sources that hit their limit are the first ones;
    the level at which the rest share what is left follows in closed form from sums before and after each.
    """
    every = Window.partitionBy()
    ordered = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(Window.orderBy("s")) - 1) % len(weights) + 1))
    ordered = ordered.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    rank = Window.orderBy("ratio", "s")
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing))
    levels = ordered.withColumn("place", F.row_number().over(rank)).withColumn("level", level)
    chosen = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("place"))).over(every)
    return levels.withColumn("chosen", chosen).select("s", "source_size", F.least(F.coalesce(F.col("weight") * F.col("chosen"), F.col("limit")), F.col("limit")).alias("target"))


def _network(x: Column, n: Column, seed: list[Column], backwards: bool = False) -> Column:
    """A permutation of 0..n-1, chosen by ``seed``."""
    rounds = [F.lit(i) for i in range(ROUNDS)]

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seed, i), n) - x, n)
        return F.when(F.pmod(F.xxhash64(*seed, i, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*(reversed(rounds) if backwards else rounds)), x, swap)


def running(rows: DataFrame, at: str, value: str, name: str, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same s before ``at`` (distinct whole numbers from 0)."""
    if not levels:
        before = Window.partitionBy("s").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    group = f"__group_{levels}"
    keyed = rows.withColumn(group, F.expr(f"{at} div {CHUNK}"))
    sums = running(keyed.groupBy("s", group).agg(F.sum(value).alias("__sum")), group, "__sum", f"__base_{levels}", levels - 1).drop("__sum")
    within = Window.partitionBy("s", group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, ["s", group])
    return summed.withColumn(name, F.col(name) + F.col(f"__base_{levels}")).drop(group, f"__base_{levels}")


def plan(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(s, blocks, slots, last_takes): how many slots each source has over all passes and what the last one takes. ``sources`` as :func:`targets` gives them."""
    b = F.lit(block).cast("long")
    s = sources.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * MOST_TIMES)).filter("source_size > 0")
    s = s.withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}")).withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * b)
    s = s.withColumn("whole", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    s = s.withColumn("tail_slot", _network(F.col("blocks") - 1, F.col("blocks"), [F.col("s"), F.col("whole")], backwards=True))
    plain = F.expr(f"(rest + {block} - 1) div {block}")
    s = s.withColumn("more", F.when(plain - 1 < F.col("tail_slot"), plain).otherwise(F.expr(f"(rest + {block} - tail + {block} - 1) div {block}")))
    short = F.when(F.col("more") - 2 >= F.col("tail_slot"), b - F.col("tail")).otherwise(F.lit(0))
    s = s.withColumn("last_takes", F.when(F.col("rest") == 0, b).otherwise(F.col("rest") - ((F.col("more") - 1) * b - short)))
    slots = F.col("whole") * F.col("blocks") + F.when(F.col("rest") == 0, F.lit(0)).otherwise(F.col("more"))
    return s.select("s", "blocks", slots.cast("long").alias("slots"), "last_takes").filter("slots > 0")


def draws(planned: DataFrame) -> DataFrame:
    """(shard, s, start, n): the multinomial source counts of each output shard, and where they begin among the source's slots. Every slot of every source is in one shard."""
    spark, n = planned.sparkSession, shuffle_partitions(planned.sparkSession)
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // SHARD_SLOTS)
    # The line of all slots in cells of CHUNK: a draw finds its source in its cell.
    based = planned.select("s", "slots", F.coalesce(F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    based = based.withColumn("high", F.col("low") + F.col("slots"))
    far = based.withColumn("far", F.explode(F.sequence(F.expr(f"low div {CHUNK * CHUNK}"), F.expr(f"(high - 1) div {CHUNK * CHUNK}")))).repartition(n, "s", "far")
    first, last = F.greatest(F.expr(f"low div {CHUNK}"), F.col("far") * CHUNK), F.least(F.expr(f"(high - 1) div {CHUNK}"), F.col("far") * CHUNK + CHUNK - 1)
    cells = far.select("s", "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    held = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("id") * SHARD_SLOTS)
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), held - 1), lambda j: F.pmod(F.xxhash64(F.lit("draw"), F.col("id"), j), F.lit(max(1, total)).cast("long")))
    each = spark.range(0, shards, 1, min(n, max(1, shards))).select(F.col("id").alias("shard"), F.explode(drawn).alias("at")).withColumn("at_cell", F.expr(f"at div {CHUNK}"))
    found = each.join(cells, (F.col("at_cell") == F.col("cell")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    counts = materialize(found.groupBy("shard", "s").agg(F.count("*").alias("c")), "draws", most_rows=total)
    placed = running(counts, "shard", "c", "start").join(planned.select("s", "slots"), "s")
    kept = placed.select("shard", "s", "start", F.least(F.col("c"), F.col("slots") - F.col("start")).alias("n")).filter("n > 0")
    sums = counts.groupBy("s").agg(F.sum("c").alias("start"))
    short = planned.join(sums, "s", "left").select(F.lit(shards - 1).cast("long").alias("shard"), "s", F.coalesce("start", F.lit(0)).alias("start"), "slots")
    return kept.unionByName(short.select("shard", "s", "start", (F.col("slots") - F.col("start")).alias("n")).filter("n > 0"))


def slots(planned: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(s, pass, k, block, takes, shard): every slot that the shards drew and the block it takes."""
    n = shuffle_partitions(planned.sparkSession)
    drawn = draws(planned).join(planned, "s").repartition(n, "shard", "s")
    each = drawn.withColumn("k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))).withColumn("pass", F.expr("k div blocks"))
    return each.select(
        "s", "pass", "k",
        _network(F.col("k") % F.col("blocks"), F.col("blocks"), [F.col("s"), F.col("pass")]).alias("block"),
        F.when(F.col("k") == F.col("slots") - 1, F.col("last_takes")).otherwise(F.lit(block).cast("long")).alias("takes"),
        "shard",
    )


def pieces(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Documents cut at block borders, and the slots of the mix. ``rows`` as :func:`sizes` gives them, written out.

    The first is (uid, doc_id, size, source_size, target, s, block, low, high, skip): words low..high-1 of the block are the document's words from ``skip`` on; a
    document without words has one row with null block.
    """
    n = rows.count()
    chunks = max(1, n // CHUNK)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks).cast("long")))
    sums = materialize(dealt.groupBy("s", "chunk").agg(F.sum("size").alias("words")), "chunks", most_rows=n)
    sources = materialize(targets(sums.groupBy("s").agg(F.sum("words").alias("source_size")), weights, share), "targets", most_rows=n)
    bases = materialize(running(sums, "chunk", "words", "base").drop("words").join(sources, "s"), "bases", most_rows=n)
    within = Window.partitionBy("s", "chunk").orderBy("doc_id", "size", "tie", "uid").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["s", "chunk"]).withColumn("start", F.col("base") + F.col("inside"))
    borders = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    cut = laid.select("uid", "doc_id", "size", "source_size", "target", "s", "start", F.explode_outer(borders).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    cut = cut.withColumn("low", low).withColumn("high", high).withColumn("skip", F.col("block") * block + F.col("low") - F.col("start"))
    planned = materialize(plan(sources, block), "planned", most_rows=n)
    return cut.drop("start"), materialize(slots(planned, block), "slots")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words of it in the mix, repeats counted), first_shard (the first output shard that holds words of it)."""
    cut, placed = pieces(materialize(sizes(docs), "sizes"), weights, share, block)
    at = placed.select(F.col("s").alias("p_s"), F.col("block").alias("p_block"), "takes", "shard")
    # The planner takes exploded rows for few and would broadcast the slots, which grow with the input: they are merged.
    found = cut.join(at.hint("merge"), (F.col("s") == F.col("p_s")) & (F.col("block") == F.col("p_block")), "left")
    words = F.when(F.col("takes").isNull(), F.lit(0)).otherwise(F.greatest(F.least("high", "takes") - F.col("low"), F.lit(0)))
    found = found.withColumn("words", words)
    summed = found.groupBy("uid", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("shard"))).alias("first_shard"))
    return summed.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS, shard_col: str | None = None) -> DataFrame:
    """The mixed corpus as rows of ``docs``: a document stands once for each pass that takes words of it, with the words taken.

    A pass that takes the whole document leaves its text as it is; else the text is cut to the words taken, with what stood between them. ``n_chars``, where there
    is one, follows the text. ``shard_col`` names a column for the output shard (of a row's first words), by which the mix can be written.
    """
    kept = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mixed-rows")
    rows = materialize(sizes(kept, row_col="__row"), "sizes")
    cut, placed = pieces(rows, weights, share, block)
    at = placed.select(F.col("s").alias("p_s"), F.col("block").alias("p_block"), "pass", "takes", "shard")
    found = cut.filter("block is not null").join(at.hint("merge"), (F.col("s") == F.col("p_s")) & (F.col("block") == F.col("p_block")))
    found = found.withColumn("words", F.least("high", "takes") - F.col("low")).filter("words > 0")
    # The runs of one document in one pass: as many as the document spans blocks.
    runs = found.groupBy(F.col("uid").alias("__uid"), F.col("pass").alias("__pass")).agg(
        F.sum("words").alias("__words"), F.first("size").alias("__size"), F.min("shard").alias("__shard"), F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("__runs")
    )
    joined = kept.join(runs, kept["__row"] == runs["__uid"])
    # A text's words are found once, as the field of an array of one, and not again for each run.
    spaced = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    once = F.array(F.struct(spaced.alias("w"), F.col("__runs").alias("r")))
    some = F.flatten(F.transform(once, lambda x: F.flatten(F.transform(x["r"], lambda r: F.slice(x["w"], (r["skip"] + 1).cast("int"), r["words"].cast("int"))))))
    cut_text = F.regexp_replace(F.array_join(some, ""), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(cut_text)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns, *([F.col("__shard").alias(shard_col)] if shard_col else []))


def query(spark, sf_dir: str) -> DataFrame:
    """op1 over the whole of ``documents``."""
    return taken(documents(spark, sf_dir))
