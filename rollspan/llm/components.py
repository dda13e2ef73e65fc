"""Connected components by alternating large-star and small-star.

Edges stay a table of (u, v) with u > v. Large-star hangs every larger neighbour of a
node on the smallest node it sees; small-star does the same for the smaller ones. Both
only take minima per node, which are combined before the shuffle, and join them back
to the edges as two written tables, so Spark can split the join of a hot node. The
fixed point is a star per component around its smallest id.
"""

from pyspark.sql import functions as F

from rollspan.session import cut


def _ordered(pairs):
    return (
        pairs.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def large_star(edges):
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"))).select(
        "u", F.least("u", "m").alias("m")
    )
    return _ordered(
        both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def small_star(edges):
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(hung.unionByName(least.select("u", F.col("m").alias("v"))))


def _mark(edges):
    return tuple(
        edges.agg(
            F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")
        ).first()
    )


def star_components(pairs):
    """(u, v) links -> (id, component) for every id that has a smaller one in reach."""
    edges = cut(_ordered(pairs))
    mark = _mark(edges)
    while mark[0]:
        edges = cut(small_star(cut(large_star(edges))))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
