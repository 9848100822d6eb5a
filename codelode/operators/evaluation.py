"""Quality of ranked lists: recall, precision, hit rate, reciprocal rank, nDCG, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_files(ranked: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, retrieved): distinct items in order of their best rank."""
    best = ranked.groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("retrieved"))


def case_metrics(cases: DataFrame, k: int) -> DataFrame:
    """Adds the five metrics at k to rows of (retrieved, relevant) arrays.

    Precision divides by the retrieved within k, not by k; nothing relevant gives 0 throughout;
    the reciprocal rank looks at the whole list. Null arrays count as empty.
    """
    none = F.array().cast(cases.schema["relevant"].dataType)
    got, want = F.coalesce("retrieved", none), F.array_distinct(F.coalesce("relevant", none))
    cut = F.slice(got, 1, k)
    found = F.size(F.array_intersect(cut, want))
    places = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(want, x), i + 1)), lambda p: p.isNotNull())
    gain = lambda array: F.aggregate(array, F.lit(0.0), lambda s, p: s + 1.0 / F.log2(p + 1.0))
    dcg = gain(F.filter(places, lambda p: p <= k))
    ideal = F.when(F.size(want) > 0, gain(F.sequence(F.lit(1), F.least(F.size(want), F.lit(k)))))
    zero: Column = F.lit(0.0)
    return cases.withColumns(
        {
            "recall": F.when(F.size(want) > 0, found / F.size(want)).otherwise(zero),
            "precision": F.when(F.size(cut) > 0, found / F.size(cut)).otherwise(zero),
            "hit": (found > 0).cast("double"),
            "reciprocal_rank": F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(zero),
            "ndcg": F.coalesce(dcg / ideal, zero),
        }
    )


def summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Means of the metrics, four digits."""
    means = [F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg")]
    return scored.groupBy(*keys).agg(F.count("*").alias("cases"), *means)


def misses(scored: DataFrame) -> DataFrame:
    return scored.filter("hit = 0")


def nearest_percentiles(df: DataFrame, value: str, *keys: str, fractions: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The value at index round_half_even(f * (n - 1)) of each group's sorted values.

    Distinct values are counted before they are gathered; a group's list is as long as it has
    distinct values.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    spread = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("n") - 1)), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions]
    return spread.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
