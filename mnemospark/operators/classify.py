"""A linear classifier of short lines: hashed features, grouped folds, a threshold at a wanted false-positive rate.

The model is Spark ML's logistic regression, so features, training and scoring
run on the rows' partitions; only the weights are on the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

BUCKETS = 1 << 12


def featured(lines: DataFrame) -> DataFrame:
    """(id, label, group, terms): terms and neighbouring pairs of terms; lines without text are left out."""
    t = text.terms(F.lower("text"))
    rows = lines.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("id", "label", "group", t.alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return rows.select("id", F.col("label").cast("double").alias("label"), "group", F.concat("t", pairs).alias("terms"))


def folds(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``fold`` by the group's hash, so that a group is never split and no order over groups is needed."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(k)))


def fit(rows: DataFrame, regularise: float = 0.01):
    pipeline = Pipeline(stages=[HashingTF(inputCol="terms", outputCol="features", numFeatures=BUCKETS, binary=True),
                                LogisticRegression(maxIter=30, regParam=regularise)])
    return pipeline.fit(rows)


def score(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", "label", vector_to_array("probability")[1].alias("score"))


def threshold_at(scored: DataFrame, most_false: float) -> float:
    """The smallest threshold whose share of false positives is at most ``most_false``: a quantile of the negatives."""
    negatives = scored.where(F.col("label") == 0)
    found = negatives.agg(F.percentile_approx("score", 1 - most_false, 10_000)).first()[0]
    return 1.0 if found is None else float(found)


def cross_validated(lines: DataFrame, k: int = 3, most_false: float = 0.05) -> DataFrame:
    """(fold, tp, fp, fn, tn): each fold scored by a model and a threshold of the others."""
    rows = folds(featured(lines), k).cache()
    out = None
    for fold in range(k):
        train = rows.where(F.col("fold") != fold)
        model = fit(train)
        limit = threshold_at(score(model, train), most_false)
        test = score(model, rows.where(F.col("fold") == fold))
        hit, real = F.col("score") > limit, F.col("label") == 1
        part = test.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"),
                        F.count_if(~hit & ~real).alias("tn")).select(F.lit(fold).alias("fold"), "tp", "fp", "fn", "tn")
        out = part if out is None else out.unionByName(part)
    return out
