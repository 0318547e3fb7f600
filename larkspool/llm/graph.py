"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import join_dealt, stage, stage_few


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in ``links`` (u, v bigint); a staged table.

    A large star ties the larger neighbours of each node to its least neighbour, a small
    star the smaller ones. The number of links never grows; when a round changes nothing,
    every node is tied to the least one of its component.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = stage(links, "links"), None
    most = links.count()  # from file footers; no round makes more
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_dealt(both, least, ["u"], F.xxhash64("v"), 2 * most).where("v > u")
        large = stage_few(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", most)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_dealt(large, least, ["u"], F.xxhash64("v"), most).where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = stage_few(small, "small-star", most)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("u"), "v").distinct()
    return stage_few(links.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component")), "components", 2 * most)
