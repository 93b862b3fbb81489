"""Connected components of a link table by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _stars(links: DataFrame) -> DataFrame:
    """links (u, v) with v < u. Large star, then small star: afterwards every node's links go to lower nodes of its component, ever nearer to its root."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return small.filter("u <> v").distinct()


def components(links: DataFrame, most_links: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't its component's least node. Ends when the star forest no longer changes; only a count and a checksum reach the driver. ``most_links`` is a bound of their number, if there is one."""
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", most_rows=most_links)
    state = _state(now)
    while state[0]:
        before, now = now, materialize(_stars(now), "stars", most_rows=2 * state[0])
        release(before)
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.bit_xor(F.xxhash64("u", "v"))).first())
