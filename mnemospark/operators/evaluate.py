"""Measures of retrieval and classification, and their uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_measures(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg, hit) for each query with gold; ranked is (query_id, doc_id, rank), gold (query_id, doc_id)."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"])
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(F.lit(math.log(2)) / F.log(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0),
                        lambda s, i: s + F.lit(math.log(2)) / F.log(i + 1.0))
    zero = F.lit(0.0)
    return size.join(per, "query_id", "left").select(
        "query_id", F.coalesce(F.col("n") / F.col("n_gold"), zero).alias("recall"), F.coalesce(1 / F.col("first"), zero).alias("rr"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"), F.col("n").isNotNull().alias("hit"))


def _poisson(round_: str, unit: str) -> Column:
    """A weight of 0 to 3 with the chances of Poisson(1), from a hash of round and unit."""
    point = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", round_, unit)), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return F.when(point < 3679, 0).when(point < 7358, 1).when(point < 9197, 2).otherwise(3)


def bootstrap(values: DataFrame, value: str, unit: str, rounds: int = 200) -> DataFrame:
    """Per round the mean over units drawn with Poisson(1) weights from a hash of (round, unit): no collect, any size.

    The weight is 0, 1, 2 or 3 with the Poisson chances; it depends on the ids alone, so rounds repeat exactly.
    """
    draws = values.select(F.col(value).alias("x"), F.col(unit).alias("u"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return draws.withColumn("w", _poisson("round", "u")).groupBy("round").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def interval(means: DataFrame) -> DataFrame:
    """One row (lowest, middle, highest): the 2.5 %, 50 % and 97.5 % points of bootstrap means, by nearest rank."""
    at = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY mean)").alias(name) for q, name in ((0.025, "lowest"), (0.5, "middle"), (0.975, "highest"))]
    return means.select(F.round("mean", 6).alias("mean")).agg(*at)


def cluster_bootstrap(rows: DataFrame, cluster: str, actual: Column, predicted: Column, rounds: int = 200) -> DataFrame:
    """One row with the 2.5 % and 97.5 % points of recall and false-positive rate when whole clusters are drawn.

    Each cluster's rows are counted first; a round weighs clusters as ``bootstrap``
    weighs units. A round without a positive (negative) row has no recall (rate).
    """
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = rows.groupBy(F.coalesce(F.col(cluster), F.lit("")).alias("u")).agg(
        F.count_if(a & p).alias("tp"), F.count_if(a).alias("pos"), F.count_if(~a & p).alias("fp"), F.count_if(~a).alias("neg"))
    draws = counts.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", _poisson("round", "u"))
    per = draws.groupBy("round").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "pos", "fp", "neg")]).select(
        F.round(F.try_divide("tp", "pos"), 6).alias("recall"), F.round(F.try_divide("fp", "neg"), 6).alias("fpr"))
    return per.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_{end}")
                     for c in ("recall", "fpr") for q, end in ((0.025, "low"), (0.975, "high"))])


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (b01, b10, p_value) of two systems' successes on the same cases: the exact two-sided binomial test.

    Only the counts of cases that one system solved and the other didn't matter; without any p is 1.
    """
    counts = pairs.agg(F.count_if(~F.col(a) & F.col(b)).alias("b01"), F.count_if(F.col(a) & ~F.col(b)).alias("b10"))
    n, k = F.col("b01") + F.col("b10"), F.least("b01", "b10")
    # the binomial chances from 0 to k, each from the one before; in logarithms, so that large n don't vanish
    start = F.struct((n * F.lit(-math.log(2))).alias("log"), F.exp(n * F.lit(-math.log(2))).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return counts.withColumn("p_value", F.round(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add)["sum"]), 6))


def set_scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) of two sets of rows with equal columns, over all keys together."""
    columns = gold.columns
    a, b = found.distinct().withColumn("f", F.lit(True)), gold.distinct().withColumn("g", F.lit(True))
    c = a.join(b, columns, "full").agg(F.count_if(F.col("f") & F.col("g")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"),
                                       F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, recall, false-positive rate."""
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    return counts.withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6)).withColumn(
        "fpr", F.round(F.try_divide("fp", F.col("fp") + F.col("tn")), 6))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def auc(df: DataFrame, score: str, label: str, buckets: int = 1000) -> DataFrame:
    """Area under the ROC curve by rank sums, ties half, over any number of scores.

    Equal scores are counted first. Ranks need a running sum over all scores;
    it is taken within ``buckets`` ranges of the score, each its own window, and
    over one row per range.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    ends = counts.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    share = F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo"))
    ranged = counts.join(F.broadcast(ends)).withColumn("range", F.floor(F.coalesce(share, F.lit(0.0)) * buckets))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum("neg").alias("neg_all")).select(
        "range", F.coalesce(F.sum("neg_all").over(before), F.lit(0)).alias("neg_before"))
    within = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ranged.withColumn("within", within).join(F.broadcast(ranges), "range").select(
        "pos", "neg", (F.col("pos") * (F.col("neg_before") + F.col("within") + F.col("neg") / 2)).alias("won"))
    return won.agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
