"""Connected components of a link table by alternating large and small stars, joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import saved


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> each u with m, the least of u and its partners, beside v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["w"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Links every greater partner of u to the least node around u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links u and its smaller partners to the least of them."""
    near = _to_least(links)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: any two columns of one orderable type, read as undirected. Returns node and root, the least node that
    can be reached, for every node that has a link to another one. Links to itself, repeated links and null ends
    count for nothing; without links the result is empty. Only the number of links and a checksum reach the driver.
    """
    a, b = links.columns[:2]
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    now, before = saved(ends, "links"), None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = sign
        now = saved(_small_star(_large_star(now)), "stars")
