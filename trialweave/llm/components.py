"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.sources.stages import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id that occurs in a link; component is the smallest id.

    Each round links the larger neighbours of every id to its smallest neighbour, then the
    smaller ones, until nothing changes.  A round is two minimum aggregates, joined back, on
    tables no larger than the links; it is written to the shared folder, so lineage stays
    short.  Only a count and a checksum reach the driver.  Rows with a null end and links of
    an id to itself are ignored; an empty table gives an empty result.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = stage(
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct(),
            "large-star",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
        )
        edges = stage(small.distinct(), "small-star")
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum")
        ).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
