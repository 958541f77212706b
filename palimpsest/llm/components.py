"""Connected components of a table of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed, sized


def _print(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b) of any orderable type; root is the smallest node of the component.

    Links may repeat, come in either order or link a node with itself (which gives no row); a link with a null end is
    none. No links: no rows. Other columns are not used. Each round is two joins on the nodes; a node
    with very many links is a skewed join key, not a group in one task. Rounds are kept by checkpoint.
    """
    a, b = F.col("a"), F.col("b")
    links = checkpointed(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    seen = None
    while (now := _print(links)) != seen and now[0]:
        seen, n = now, now[0]
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(sized(least, 2 * n), "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(least, 2 * n), "a").select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where(a != b)
        links = checkpointed(small.distinct(), 2 * n)
    return links.select(a.alias("node"), b.alias("root")).unionByName(links.select(b.alias("node"), b.alias("root")).distinct())
