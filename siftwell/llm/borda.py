"""One ranking from several differently-scaled scores, by Borda count.

Within each list the items take competition places per score, ties share the average place, items
without a usable score (null, NaN, infinite) share the average of the places behind all that have
one, and the weighted points are summed; equal sums are ordered by identifier.

Places are computed without gathering a list in one task: equal values are counted first, the counts
are range-partitioned by (list, score, value), and each range's running count starts from the total
of the ranges before it. A list that holds a third of all rows is spread over as many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut


def usable(c: Column) -> Column:
    """The score if it can be ranked, else null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def places(long: DataFrame) -> DataFrame:
    """(list, score_name, value) -> twice the averaged place, so that it stays whole.

    long: (list, score_name, item, value), higher values first, values never null, one row per item.
    """
    spark = long.sparkSession
    ties = long.groupBy("list", "score_name", "value").agg(F.count("*").alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        ties.repartitionByRange(n, "list", "score_name", F.desc("value")).select("*", F.spark_partition_id().alias("part"))
    )
    parts = ranged.groupBy("list", "score_name", "part").agg(F.sum("n").alias("part_n"))
    every = Window.partitionBy("list", "score_name")
    before = F.sum("part_n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("list", "score_name", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("list", "score_name", "part").orderBy(F.desc("value")))
    return (
        ranged.select("*", inside.alias("upto"))
        .join(parts, ["list", "score_name", "part"])
        .select("list", "score_name", "value", (2 * (F.col("before") + F.col("upto")) - F.col("n") + 1).alias("place2"))
    )


def borda(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Rank items of each list: (list, item, points), more points first, then the smaller item.

    scores: (list, item, one column per key of weights), one row per item, higher is better. An item
    without a usable score keeps the mid-rank of the places behind the scored ones. Null lists and
    items are left out; an empty table gives an empty ranking.
    """
    names = list(weights)
    scores = cut(scores.select("list", "item", *[usable(F.col(x).cast("double")).alias(x) for x in names]).dropna(subset=["list", "item"]))
    # Items of each list, and of them those with each score.
    sizes = scores.groupBy("list").agg(F.count("*").alias("_items"), F.struct(*[F.count(F.col(x)).alias(x) for x in names]).alias("_scored"))
    stacked = "stack({}, {}) as (score_name, value)".format(len(names), ", ".join(f"'{x}', `{x}`" for x in names))
    long = scores.selectExpr("list", "item", stacked).where("value is not null")
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    got = long.join(places(long), ["list", "score_name", "value"]).groupBy("list", "item").agg(F.sum(F.element_at(w, F.col("score_name")) * F.col("place2")).alias("_p2"))
    # n - place for each score; a missing one has place (scored + 1 + n) / 2, and an unscored list (1 + n) / 2.
    behind = sum((F.when(F.col(f"`{k}`").isNull(), float(v) * (F.col("_scored")[k] + 1 + F.col("_items"))).otherwise(0.0) for k, v in weights.items()), F.lit(0.0))
    out = scores.join(got, ["list", "item"], "left").join(sizes, "list")
    points = float(sum(weights.values())) * F.col("_items") - (F.coalesce(F.col("_p2"), F.lit(0.0)) + behind) / 2
    return out.select("list", "item", points.alias("points"))


def top(ranking: DataFrame, k: int) -> DataFrame:
    """The first k items of each list with their place; the window's group limit runs before its shuffle."""
    w = Window.partitionBy("list").orderBy(F.desc("points"), "item")
    return ranking.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
